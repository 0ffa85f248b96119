"""Sources and sinks: change files with rejects, snapshots, partitioned appends."""

from pyspark.sql import functions as F

from mercato.session import scratch_path
from mercato.sources.changes import CORRUPT, read_changes, write_changes
from mercato.sources.domain import DOMAIN_SCHEMAS, load_tables
from mercato.sources.sinks import append_partitioned, current_snapshot, read_snapshot, write_snapshot


def test_changes_keep_bad_lines_aside(spark):
    df = spark.createDataFrame([(1, "a@b.co"), (2, "c@d.co"), (3, None)], "seq long, email string")
    path = write_changes(df, scratch_path(spark, "t-changes"), F.col("seq") == 2)
    good, bad = read_changes(spark, path, df.schema)
    assert sorted(r.seq for r in good.collect()) == [1, 3]
    rows = bad.collect()
    assert len(rows) == 1 and rows[0][CORRUPT].startswith('"seq":2')


def test_empty_object_is_a_row_of_nulls(spark):
    path = scratch_path(spark, "t-empty")
    spark.createDataFrame([("{}",)], "value string").write.text(path)
    good, bad = read_changes(spark, path, DOMAIN_SCHEMAS["users"])
    assert bad.count() == 0 and good.first().email is None


def test_snapshot_never_overwrites_what_is_read(spark, seed):
    root = scratch_path(spark, "t-snap")
    first = write_snapshot(seed["products"], root)
    before = read_snapshot(spark, root)
    second = write_snapshot(seed["products"].where("price_cents > 4000"), root)
    assert first != second and current_snapshot(spark, root) == second
    assert before.count() == 6 and read_snapshot(spark, root).count() == 3
    # a snapshot that never finished is not current
    seed["products"].write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{root}/snapshot-9-unfinished")
    assert current_snapshot(spark, root) == second


def test_audit_sink_partitioned_by_action(spark):
    path = scratch_path(spark, "t-audit")
    rows = spark.createDataFrame([("a", "user.login"), ("b", "user.register"), ("c", "user.login")],
                                 "id string, action string")
    append_partitioned(rows, path, "action")
    append_partitioned(rows.limit(1), path, "action")
    back = spark.read.parquet(path)
    assert back.where("action = 'user.login'").count() == 3


def test_load_tables_declared_schema(spark, seed):
    folder = scratch_path(spark, "t-tables")
    for name, df in seed.items():
        df.write.parquet(f"{folder}/{name}")
    tables = load_tables(spark, folder)
    assert tables["users"].schema == DOMAIN_SCHEMAS["users"] and tables["products"].count() == 6
