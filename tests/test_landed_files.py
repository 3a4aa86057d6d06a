"""Many landed files: how they are written and listed."""
from __future__ import annotations

import datetime as dt
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

from compare import differences
from epitide import catalog
from epitide.catalog import landed
from epitide.sources import cells, files

ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"


def day(year):
    return dt.datetime(year, 3, 1)


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """Own tables with repeated rows and nulls in all but the keys of customers and orders."""
    out = tmp_path_factory.mktemp("rows")
    orders = [(k, k * 7 % 900, "O", 1.0, day(1995 + k % 3) if k % 11 else None, "1-URGENT" if k % 5 else None) for k in range(3000)]
    orders += orders[:50] + [(1, 5, "O", 1.0, day(1995), "é ☃"), (0, 5, "O", 1.0, day(1995), "9")]
    customers = [(k, k % 25 if k % 13 else None) for k in range(900)] + [(5, 5), (5, 5)]
    spark.createDataFrame(orders, ORDERS).write.parquet(f"{out}/orders.parquet")
    spark.createDataFrame(customers, "c_custkey bigint, c_nationkey bigint").write.parquet(f"{out}/customer.parquet")
    return str(out)


def landed_bytes(root):
    top = Path(root.removeprefix("file:"))
    return {str(f.parent.relative_to(top)): f.read_bytes() for f in top.rglob("*") if f.is_file() and not f.name.startswith((".", "_"))}


def sorted_lines(found):
    return {k: sorted(v.split(b"\n")) if k.startswith("customers") else v for k, v in found.items()}


def test_tasks_write_what_spark_writes(spark, rows, monkeypatch):
    """The files of tasks and those of Spark's writer, where the folder is on another file system."""
    ours = landed.landed_orders(spark, rows)
    assert not list(Path(ours.removeprefix("file:")).rglob("*.crc"))  # none went through Hadoop's local file system
    with monkeypatch.context() as m:
        m.setattr(landed.tables, "qualified", lambda spark, path: f"other:{path}")
        other = landed.landed_orders(spark, rows)
    assert list(Path(other.removeprefix("file:")).rglob("*.crc"))
    assert len(landed_bytes(ours)) > 30 and sorted_lines(landed_bytes(ours)) == sorted_lines(landed_bytes(other))


def test_rows_without_a_customer(spark, rows, tmp_path, monkeypatch):
    df = spark.read.parquet(f"{rows}/orders.parquet").selectExpr("o_orderkey", "if(o_orderkey % 2 = 0, null, o_custkey) AS o_custkey", "o_orderdate", "o_orderpriority")
    df.write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{rows}/customer.parquet").selectExpr("if(c_custkey > 800, null, c_custkey) AS c_custkey", "c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    ours = landed_bytes(landed.landed_orders(spark, str(tmp_path)))
    with monkeypatch.context() as m:
        m.setattr(landed.tables, "qualified", lambda spark, path: f"other:{path}")
        other = landed_bytes(landed.landed_orders(spark, str(tmp_path)))
    assert any("__HIVE_DEFAULT_PARTITION__" in k for k in ours) and sorted_lines(ours) == sorted_lines(other)


def test_files_take_their_names_when_whole(tmp_path):
    """A folder may go on in the next batch; a task that fails leaves no visible part of a file, its retry writes all of them."""
    batches = [pa.RecordBatch.from_pydict({"folder": f, "line": [x.encode() for x in lines]}) for f, lines in
               ((["a=1", "a=1", "a=2"], "xyz"), ([], ""), (["a=2", "a=3"], "uv"))]

    def broken():
        yield from batches[:1]
        raise OSError("lost")

    write = landed._files_of_folders(str(tmp_path), ".txt", b"h\n")
    with pytest.raises(OSError):
        list(write(broken()))
    assert landed_bytes(str(tmp_path)) == {"a=1": b"h\nx\ny\n"}
    assert [b.to_pydict() for b in write(iter(batches))] == [{"files": [3]}]
    assert landed_bytes(str(tmp_path)) == {"a=1": b"h\nx\ny\n", "a=2": b"h\nz\nu\n", "a=3": b"h\nv\n"}
    assert [b.to_pydict() for b in write(iter(()))] == [{"files": [0]}]


def listing_tasks(spark, label, call):
    """Most tasks of a stage among the jobs that the call runs."""
    sc = spark.sparkContext
    sc.setJobGroup(label, label)
    try:
        call()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    status = sc.statusTracker()
    stages = [s for j in status.getJobIdsForGroup(label) for s in status.getJobInfo(j).stageIds]
    return max(status.getStageInfo(s).numTasks for s in stages)


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """More folders, two deep, than the session may use tasks for listing."""
    root = tmp_path_factory.mktemp("folders")
    for i in range(150):
        (root / f"kind={i % 2}" / f"block={i}").mkdir(parents=True)
        (root / f"kind={i % 2}" / f"block={i}" / ("a.csv" if i % 3 else "a.txt")).write_text("n,m\n" + "1,2\n" * i)
    return str(root)


@pytest.mark.parametrize("read", [files.inventory, files.checksums, cells.read_rows])
def test_listing_takes_few_tasks(spark, folders, read):
    """75 folders on a level were 75 tasks."""
    found = []
    before = spark.conf.get(files.LISTING)
    most = listing_tasks(spark, f"listing-{read.__name__}", lambda: found.append(read(spark, folders)))
    assert most <= 4 * spark.sparkContext.defaultParallelism < 75
    assert found[0].select("path").distinct().count() == 150 and spark.conf.get(files.LISTING) == before


def test_smaller_listing_setting_stays(spark, folders):
    before = spark.conf.get(files.LISTING)
    spark.conf.set(files.LISTING, 2)
    try:
        assert listing_tasks(spark, "listing-two", lambda: files.under(spark, folders, "*.csv")) == 2
        assert spark.conf.get(files.LISTING) == "2"
    finally:
        spark.conf.set(files.LISTING, before)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.under(spark, folders + "/none")
    assert spark.conf.get(files.LISTING) == before


def test_inventory_takes_few_tasks(spark, folders, monkeypatch):
    """Files that count as a task's worth each were 150 tasks."""
    monkeypatch.setattr(files, "INVENTORY_TASKS", 10, raising=False)
    asked = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1)
    try:
        found, sizes = files.inventory(spark, folders), []
        most = listing_tasks(spark, "inventory", lambda: sizes.extend(files.size_by_suffix(found).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", asked)
    assert most <= 4 * spark.sparkContext.defaultParallelism < 150
    expected = {s: [4 + 4 * i for i in range(150) if (i % 3 == 0) == (s == ".txt")] for s in (".csv", ".txt")}
    assert {r.suffix: (r.n_files, r.total_bytes) for r in sizes} == {s: (len(b), sum(b)) for s, b in expected.items()}


@pytest.mark.parametrize("name", ["file_inventory", "file_checksums", "files_by_suffix"])
def test_queries_on_own_rows(spark, rows, tmp_path, name):
    """Customers without a nation are left out: in the SQL their whole line is null."""
    spark.read.parquet(f"{rows}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{rows}/customer.parquet").where("c_nationkey IS NOT NULL").write.parquet(f"{tmp_path}/customer.parquet")
    found, statements = catalog.load()
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    df = found[name](spark, str(tmp_path))
    assert df.count() > 1 and differences(df, con, statements[name]) == []
